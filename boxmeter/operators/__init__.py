"""boxmeter.operators"""
