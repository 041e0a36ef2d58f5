"""boxmeter.plans"""
